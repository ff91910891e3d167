"""Evaluation analytics for labelled predictors, expressed as Spark DataFrames."""
