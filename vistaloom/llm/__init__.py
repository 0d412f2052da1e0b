"""Training-data operators: chat formatting, deduplication, sharding, counting, decontamination, classifiers, packing.

Nothing outside this folder imports it.
"""
