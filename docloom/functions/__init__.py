"""Column functions shared by predicates and indexes."""
