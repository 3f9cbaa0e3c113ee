"""Tidewater: composable analytic queries that run as Spark DataFrame plans."""
