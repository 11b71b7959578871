"""End-to-end plans: scoring, agreement, import, export, status, query generation."""
