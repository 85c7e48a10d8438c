"""Ways to a plan: SQL text, the lazy builder, and plans as JSON."""
