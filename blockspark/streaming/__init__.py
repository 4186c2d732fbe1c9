"""blockspark.streaming"""
