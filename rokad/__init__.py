"""Double-entry books, indirect tax, withholding and bank reconciliation as Spark DataFrame jobs."""
