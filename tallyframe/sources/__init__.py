from tallyframe.sources.dictionary import dictionary_layout, read_dictionary, text_labels, value_labels
from tallyframe.sources.microdata import (
    Field, land, land_bucketed, land_extract, landed_or, malformed_fields, parse_records, read_hierarchical, read_rectangular,
    split_records,
)
from tallyframe.sources.tables import literal_table, read_csv, read_table, write_csv

__all__ = [
    "Field", "dictionary_layout", "land", "land_bucketed", "land_extract", "landed_or", "literal_table", "malformed_fields",
    "parse_records", "read_csv",
    "read_dictionary", "read_hierarchical", "read_rectangular", "read_table", "split_records",
    "text_labels", "value_labels", "write_csv",
]
