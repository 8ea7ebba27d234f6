"""lodewell.streaming"""
