"""Operators on tables of trajectories, tokens and prompts."""
