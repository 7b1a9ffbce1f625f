"""Training-data operators: filters, joins, encoders and mixers over document tables.

Nothing outside this subpackage imports it.
"""
