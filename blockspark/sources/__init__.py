"""blockspark.sources"""
