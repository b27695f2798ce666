"""End-to-end plans: which tables follow from a panel, written once where several steps read them."""
