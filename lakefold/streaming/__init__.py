"""lakefold.streaming"""
