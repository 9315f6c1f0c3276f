"""Column expressions shared by the jobs; nothing here touches a DataFrame's plan."""
