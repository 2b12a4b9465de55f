"""Reading transactions and writing results."""
