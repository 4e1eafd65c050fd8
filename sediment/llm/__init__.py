"""Training-data operators: filters, scans, joins, packing and classifiers over text corpora."""
