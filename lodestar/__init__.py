"""lodestar — workbook analytics (filters, LOD, table calculations, calculated
fields, star joins, property extraction, warehouse load and report tiles) as
Spark DataFrame operators."""

__version__ = "0.1.0"
