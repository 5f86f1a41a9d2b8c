"""lakefold.plans"""
