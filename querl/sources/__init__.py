"""Tables: the catalog, the delimited-file loader and the ways results are written."""
