"""neolexis: emergent-vocabulary analytics on Spark."""
