"""Training-data operators: extraction, decontamination, scoring, linking,
sharding, license scans, quality, mixing and near-duplicate detection.

Each module holds one operator (general interface) and its thin registered
query; ``registry`` gathers the queries and their SQL.
"""
