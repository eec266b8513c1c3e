"""Statement scans: files to movements, accounts, balances and trades."""
