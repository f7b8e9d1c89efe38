"""The registered queries of the spreadsheet engine, each with the SQL that must give the same rows."""
