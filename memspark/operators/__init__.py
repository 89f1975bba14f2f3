"""memspark.operators"""
