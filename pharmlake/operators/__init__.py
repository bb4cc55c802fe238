"""DataFrame -> DataFrame operators (cleaning, splits, joins, metrics, histories, text)."""
