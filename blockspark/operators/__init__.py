"""blockspark.operators"""
