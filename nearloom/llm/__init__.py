"""Operations of a training-data pipeline: deduplication, filtering, extraction, packing.

Nothing outside this folder imports it.  Each module holds one operator; ``registry`` holds
the thin ``opN_<name>`` queries and their SQL.
"""
