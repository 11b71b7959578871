"""Streaming forms of two operators. Batch is the contract; these keep tables fresh between batches."""
