"""sparkloom: document retrieval, retrieval analytics and corpus preparation as Spark plans."""
