"""Model families, their evaluation on blocked folds, and the population search."""
