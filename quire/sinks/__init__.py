"""Files written from result tables."""
