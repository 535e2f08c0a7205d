"""Record layouts, landed JSON documents, the table store and the test-table mapping."""
