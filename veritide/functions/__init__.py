"""Column functions over text, and scorer interfaces."""
