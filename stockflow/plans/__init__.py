"""Business results built from the operators: KPIs, visibility, forecasts, stock policies, models."""
