"""The search for recipes: genetic operators, islands, evaluation, ensembles and tuning."""
