"""Training-data operators for language-model corpora, one module per operator.

Every operator takes and returns DataFrames (or Columns) and runs its Python, where it
has any, in Arrow batches inside tasks.  ``queries`` registers the catalogue entries.
Nothing else in the library imports this subpackage.
"""
