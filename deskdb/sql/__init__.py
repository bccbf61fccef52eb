"""The single-table SELECT dialect: tokens, syntax tree, parser and compiler to Spark columns."""
