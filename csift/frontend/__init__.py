"""The C front end: tokens, macros, syntax, control flow. Pure Python; runs once a file inside Spark's Arrow workers."""
