"""Error texts."""

#: Texts that callers may look for.
NULL_KEY = "Write Error: Key can't be null or undefined!"
BAD_VALUE = "Write Error: Data must be a string or Buffer!"
NESTED_TX = "Can't do nested transactions, finish the current one first!"
COMPACTING = "Already compacting!"
