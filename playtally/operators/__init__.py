"""Relational operators: frames in, one lazy frame out, no actions."""
