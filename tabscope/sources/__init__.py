from tabscope.sources.tables import TABLES, read_table
from tabscope.sources.fixtures import v_defect, v_sales, v_nonlin, v_linear, VIEW_SQL
from tabscope.sources.csv import read_csv
from tabscope.sources.sink import write_tables

__all__ = [
    "TABLES", "read_table", "v_defect", "v_sales", "v_nonlin", "v_linear", "VIEW_SQL",
    "read_csv", "write_tables",
]
