"""Business questions, one function each: tables in, a lazy DataFrame out."""
