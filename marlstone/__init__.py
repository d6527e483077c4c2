"""Marlstone: DataFrame operators for curating chat corpora and analysing evaluation results on Spark."""
