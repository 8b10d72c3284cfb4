"""Analytics over the program corpus: statements, lineage, plan, audit, ledgers, call trace."""
