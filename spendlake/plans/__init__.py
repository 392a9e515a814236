"""The composite jobs a user calls: import, embed, ledger, query, ask."""
