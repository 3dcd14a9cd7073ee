"""Graph operators: edge tables, statistics, wedges, ownership."""
