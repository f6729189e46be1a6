"""Driver-side decisions: routing a question, planning its subqueries, choosing channels."""
