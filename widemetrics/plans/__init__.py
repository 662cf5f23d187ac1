"""The documented dashboard queries."""
