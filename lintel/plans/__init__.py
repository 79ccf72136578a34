"""Static data, compiled rules and the queries built from operators."""
