"""Query catalogue and strategy planner."""
