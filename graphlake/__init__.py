"""graphlake: a PySpark engine for knowledge graphs built from source trees and documents."""
