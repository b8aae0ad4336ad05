"""Sources and sinks: document folders, text files, keyed stores, table dumps."""
