"""lodewell.operators"""
