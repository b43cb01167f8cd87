"""Training-data operators. Nothing outside this folder imports it, apart from the entry file's guard."""
