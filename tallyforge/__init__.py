"""tallyforge: spreadsheet, document and corpus analytics on Spark."""
