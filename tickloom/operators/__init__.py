"""DataFrame-to-DataFrame operators over bars, signals, ledgers, chains and quotes."""
