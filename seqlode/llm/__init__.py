"""Operators for preparing training corpora. Nothing else in the library imports this subpackage.

What holds for all of them, unless an operator says otherwise:

* Nulls may stand in any column. A null text counts as empty, a null id as a value of its own.
* Whole texts are processed, however long; a single text must fit into a worker's memory a few times over.
* Rows that repeat an id or a whole row are rows of their own. Ties are broken by id, then by a hash of the text or by
  the row's place in a written table.
* Columns that an operator does not read are ignored, or passed through where it adds columns; their names may be
  those of its own results, which then replace them.
* An empty table gives an empty result with the same columns.
"""
