"""Sources: landed feed bodies, catalogues, metadata payloads, driver-table stand-ins."""
