"""lakefold.sources"""
