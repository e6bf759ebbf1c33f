"""Operations of a training-data pipeline: ten operators over document and embedding tables.

Nothing else in the library imports this subpackage.
"""
