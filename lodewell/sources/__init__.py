"""lodewell.sources"""
