"""factlake: relational kernels over code facts and plain tables, planned by Spark SQL."""

VERSION = "0.2.0"
