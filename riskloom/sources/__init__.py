from riskloom.sources.tables import (  # noqa: F401
    read_table, events_transactions, events_identity, merged_transactions,
    card_device_pairs, TX_SCHEMA, ID_SCHEMA,
)
