"""memspark.streaming"""
