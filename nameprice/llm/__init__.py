"""Training-data operators: each module holds one operator and its real outputs;
`queries.py` derives the registered `opN_<name>` digests from them. Nothing else
in the library imports this subpackage."""
