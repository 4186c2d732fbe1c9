"""blockspark.plans"""
