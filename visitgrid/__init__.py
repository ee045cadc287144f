"""Visit analytics and demand forecasting as lazy Spark DataFrame operators."""
