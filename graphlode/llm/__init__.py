"""Operators for preparing training corpora. Nothing else in graphlode imports this subpackage."""
