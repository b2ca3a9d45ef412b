"""Operations of a training-data pipeline: filters, deduplication, search, sharding, formatting and tokenization.

Nothing else in the library imports this subpackage.
"""
