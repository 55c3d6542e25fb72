"""Operators: panel construction, descriptives, joins, regression and DiD estimators."""
