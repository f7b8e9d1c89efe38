"""Sources and sinks: workbook files, run history, reports."""
