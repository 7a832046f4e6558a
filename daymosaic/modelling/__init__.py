"""MLlib models over feature tables: splits, preparation, learners, evaluation."""
