"""Panel verbs: DataFrame in, DataFrame out, all lazy."""
