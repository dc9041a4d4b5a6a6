"""panelspark: DataFrame operators for building, auditing and studying entity x time panels."""
