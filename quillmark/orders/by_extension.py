"""An order that SortKeys.load_dir finds: file type first, then how long the name is."""

# ruff: noqa: F821 - register_sort is given by the loader.
register_sort("By type and length", lambda item: f"{item['type']} {len(item['name']):04d}")
