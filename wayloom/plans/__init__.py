"""The travel domain as views over the star-schema tables, and the queries over them."""
