"""lakefold.functions"""
