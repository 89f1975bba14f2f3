"""memspark.functions"""
