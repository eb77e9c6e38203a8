"""sparkloom: code and document intelligence as PySpark DataFrame programs."""
