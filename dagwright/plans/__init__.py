"""Which physical strategy a computation takes, and the registered queries."""
