"""Context, joins, roll-ups, policies, evaluation and audits over DataFrames."""
