"""lodewell.functions"""
