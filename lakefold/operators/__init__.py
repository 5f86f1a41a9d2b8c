"""lakefold.operators"""
